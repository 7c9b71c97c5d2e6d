"""Analytics over yearly exam microdata, written as Spark DataFrame transformations."""
