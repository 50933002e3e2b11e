"""evidentia.functions"""
