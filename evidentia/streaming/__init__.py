"""evidentia.streaming"""
