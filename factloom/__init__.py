"""Factloom: text records to classed facts, measured, on Spark."""
