"""Results as JSON."""

from martlens.sinks.json_document import (
    chart_arrays,
    json_fragments,
    state_document,
    write_chart_arrays,
    write_json,
)

__all__ = ["chart_arrays", "json_fragments", "state_document", "write_chart_arrays", "write_json"]
