"""tessel.functions"""
