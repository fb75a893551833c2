"""placeloom.plans"""
