"""Operators over DataFrames: identities, classification, matching, clustering, fusion, reports."""
