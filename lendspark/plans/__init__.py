"""lendspark.plans"""
