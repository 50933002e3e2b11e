"""evidentia.operators"""
