"""Connected components; see winnowlane.operators.components."""

from winnowlane.operators.components import components

__all__ = ["components"]
