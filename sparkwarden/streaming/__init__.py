"""Detections and hunts on streams of events, with the batch rules' declarations."""
