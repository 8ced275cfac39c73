"""lendspark.streaming"""
