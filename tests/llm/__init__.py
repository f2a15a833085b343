"""Tests of the operators over text."""
