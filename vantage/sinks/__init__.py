"""Result writers."""
