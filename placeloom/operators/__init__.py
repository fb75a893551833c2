"""placeloom.operators"""
