"""Registered queries: domain tables derived from the given ones, and operators over them."""
