"""loomstone.sources"""
