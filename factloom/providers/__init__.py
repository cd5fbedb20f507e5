"""Models behind one interface; the only place where data leaves the JVM."""
