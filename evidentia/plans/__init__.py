"""evidentia.plans"""
