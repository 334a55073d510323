"""siltwork.operators"""
