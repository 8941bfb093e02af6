"""newsloom.registry"""
