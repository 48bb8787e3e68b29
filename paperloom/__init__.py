"""Exam-corpus analytics on Spark DataFrames."""
