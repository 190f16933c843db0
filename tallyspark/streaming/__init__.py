"""Reserved: every operator of this engine is a batch one; gap sessions are in ``operators.report.passes``."""
