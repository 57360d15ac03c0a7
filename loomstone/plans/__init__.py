"""loomstone.plans"""
