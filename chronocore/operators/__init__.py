"""The analytic operators."""
