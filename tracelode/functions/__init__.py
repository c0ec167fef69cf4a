"""Column functions. All are built from JVM-side expressions unless the name says otherwise."""
