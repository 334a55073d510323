"""siltwork.plans"""
