"""The same operators on streams."""

from plumbline.streaming.streams import (
    dedupe_stream,
    plan_stream,
    quality_windows,
    run_plan_stream,
    vocabulary_sink,
)

__all__ = ["dedupe_stream", "plan_stream", "quality_windows", "run_plan_stream", "vocabulary_sink"]
