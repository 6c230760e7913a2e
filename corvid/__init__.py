"""Corvid: catalog matching, audit and evaluation operators on PySpark."""
