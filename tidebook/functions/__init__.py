"""tidebook.functions"""
