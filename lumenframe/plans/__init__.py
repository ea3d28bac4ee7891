"""Chains of operators, the registry, data-quality rows and the registered queries."""
