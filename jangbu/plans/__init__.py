"""Typed query plans and their execution."""
