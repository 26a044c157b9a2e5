"""Evaluation analytics for voice-command and tool-calling agents, as Spark DataFrame jobs."""
