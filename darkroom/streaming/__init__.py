"""Micro-batch forms of the library's operators."""
