"""Special functions as Catalyst expressions and as numpy code."""
