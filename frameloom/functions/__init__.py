"""Functions on columns: scalars, arrays, ragged sequences. All are built-in expressions, evaluated in the JVM."""
