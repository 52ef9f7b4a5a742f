"""The function library: Column builders that stay in the JVM, and Arrow functions for JSON, where exact text matters."""
