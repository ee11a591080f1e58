"""Vulnerability and patch management jobs as Spark DataFrame transformations."""
