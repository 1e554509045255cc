"""Policies whose probabilities come from text models: prompts, caches and replay. No model runs here."""
