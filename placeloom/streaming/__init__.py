"""placeloom.streaming"""
