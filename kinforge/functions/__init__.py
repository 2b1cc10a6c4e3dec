"""kinforge.functions"""
