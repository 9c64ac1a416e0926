"""Reusable DataFrame operators the detections and hunts are built from."""
