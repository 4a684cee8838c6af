"""Helpline transcript analytics as plain functions over Spark DataFrames."""
