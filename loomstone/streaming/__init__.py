"""loomstone.streaming"""
