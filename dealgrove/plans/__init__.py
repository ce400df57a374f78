"""Composed jobs: digest, daily and weekly runs, and the sample deal view."""
