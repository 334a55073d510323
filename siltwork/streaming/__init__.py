"""siltwork.streaming"""
