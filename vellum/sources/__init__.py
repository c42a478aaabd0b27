"""vellum.sources"""
