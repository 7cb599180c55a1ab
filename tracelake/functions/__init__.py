"""Column functions: expressions over built-in Spark functions, without Python in the data path."""
