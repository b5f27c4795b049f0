"""Webhook ledger operators, batch and streaming."""
