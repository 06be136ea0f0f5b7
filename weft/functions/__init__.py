"""Scalar functions with the semantics of the query surfaces, as Column builders."""
