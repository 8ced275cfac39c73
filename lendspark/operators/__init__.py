"""lendspark.operators"""
