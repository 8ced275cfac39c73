"""lendspark.functions"""
