"""tidebook.plans"""
