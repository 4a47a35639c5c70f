"""Registered queries by family: each name with its Spark function and, where SQL states it, its SQL."""
