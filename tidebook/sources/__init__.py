"""tidebook.sources"""
