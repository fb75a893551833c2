"""placeloom.sources"""
