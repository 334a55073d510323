"""siltwork.sources"""
