"""From captured files to facts, and from facts to entities and relations."""
