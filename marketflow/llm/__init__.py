"""Operators of a large-scale text-preparation pipeline (see the README section "Training-data operators")."""
