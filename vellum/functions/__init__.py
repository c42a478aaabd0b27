"""vellum.functions"""
