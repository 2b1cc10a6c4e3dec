"""kinforge.operators"""
