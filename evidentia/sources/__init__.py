"""evidentia.sources"""
