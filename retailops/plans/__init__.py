"""Composed plans: prepared inputs, result bundles, the query catalog and its SQL oracle."""
