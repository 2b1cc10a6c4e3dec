"""kinforge.streaming"""
