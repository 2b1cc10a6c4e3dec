"""kinforge.sources"""
