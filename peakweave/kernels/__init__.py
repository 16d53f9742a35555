"""Small numpy kernels without Spark; they run inside grouped pandas functions."""
