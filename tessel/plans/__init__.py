"""tessel.plans"""
