"""tessel.sources"""
