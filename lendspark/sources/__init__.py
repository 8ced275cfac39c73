"""lendspark.sources"""
