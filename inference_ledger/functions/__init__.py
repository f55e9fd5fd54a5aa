"""Column-expression builders (native Spark expressions, no UDFs except the
exact tokenizer in ``tokens``)."""
