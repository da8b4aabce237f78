"""Column-expression builders (JVM-side, whole-stage-codegen friendly)."""
