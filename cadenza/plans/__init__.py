"""Whole pipelines out of operators: diarization, replays, context and exports."""
