"""tidebook.streaming"""
