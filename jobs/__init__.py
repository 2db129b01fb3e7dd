"""Runnable jobs on tables of reads; each is a function that takes a session, and a command line around it."""
