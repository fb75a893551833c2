"""placeloom.functions"""
