"""queries"""
