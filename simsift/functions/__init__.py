"""Column-level functions (``Column -> Column``); all run inside the JVM."""
