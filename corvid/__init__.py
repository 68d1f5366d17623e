"""corvid: DataFrame-first analytics over agent-run, code-inventory, trace,
translation, byte, image and line data.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a column
expression) built from the public PySpark API, so Catalyst plans, prunes and
pushes down, and whole-stage codegen runs the hot loops.
"""

from corvid.session import ensure_checkpoint_dir, get_session

__all__ = ["get_session", "ensure_checkpoint_dir"]
