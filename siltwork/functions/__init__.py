"""siltwork.functions"""
