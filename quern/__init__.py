"""quern: query and data-processing operators written as Spark DataFrame plans."""
