"""Where operators cut lineage; see winnowlane.scratch."""

from winnowlane.scratch import clear, drop, drop_path, fresh_path, input_bytes, materialize, only, parts, shared_dir

__all__ = ["clear", "drop", "drop_path", "fresh_path", "input_bytes", "materialize", "only", "parts", "shared_dir"]
