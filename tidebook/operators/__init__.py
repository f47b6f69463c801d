"""tidebook.operators"""
